"""Paragraphs of twelve words and more of well-known licenses, whole, with their labels.

Words as ``license_scan.words`` splits them. A paragraph that GPL versions and their relatives
have in common is labelled ``gpl``; one that stands nearly the same in a license without a label
here (MPL 1.1, the GFDL) is not listed. Names of copyright holders are the general ones.
"""

PARAGRAPHS = """
apache-2.0: apache license version 2 0 january 2004 http www apache org licenses
apache-2.0: license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document
apache-2.0: licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license
apache-2.0: legal entity shall mean the union of the acting entity and all other entities that control are controlled by or are under common control
    with that entity for the purposes of this definition control means i the power direct or indirect to cause the direction or management of such
    entity whether by contract or otherwise or ii ownership of fifty percent 50 or more of the outstanding shares or iii beneficial ownership of such
    entity
apache-2.0: you or your shall mean an individual or legal entity exercising permissions granted by this license
apache-2.0: source form shall mean the preferred form for making modifications including but not limited to software source code documentation source
    and configuration files
apache-2.0: object form shall mean any form resulting from mechanical transformation or translation of a source form including but not limited to
    compiled object code generated documentation and conversions to other media types
apache-2.0: work shall mean the work of authorship whether in source or object form made available under the license as indicated by a copyright
    notice that is included in or attached to the work an example is provided in the appendix below
apache-2.0: derivative works shall mean any work whether in source or object form that is based on or derived from the work and for which the
    editorial revisions annotations elaborations or other modifications represent as a whole an original work of authorship for the purposes of this
    license derivative works shall not include works that remain separable from or merely link or bind by name to the interfaces of the work and
    derivative works thereof
apache-2.0: contribution shall mean any work of authorship including the original version of the work and any modifications or additions to that work
    or derivative works thereof that is intentionally submitted to licensor for inclusion in the work by the copyright owner or by an individual or
    legal entity authorized to submit on behalf of the copyright owner for the purposes of this definition submitted means any form of electronic
    verbal or written communication sent to the licensor or its representatives including but not limited to communication on electronic mailing lists
    source code control systems and issue tracking systems that are managed by or on behalf of the licensor for the purpose of discussing and
    improving the work but excluding communication that is conspicuously marked or otherwise designated in writing by the copyright owner as not a
    contribution
apache-2.0: contributor shall mean licensor and any individual or legal entity on behalf of whom a contribution has been received by licensor and
    subsequently incorporated within the work
apache-2.0: 2 grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual
    worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly
    perform sublicense and distribute the work and such derivative works in source or object form
apache-2.0: 3 grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide
    non exclusive no charge royalty free irrevocable except as stated in this section patent license to make have made use offer to sell sell import
    and otherwise transfer the work where such license applies only to those patent claims licensable by such contributor that are necessarily
    infringed by their contribution s alone or by combination of their contribution s with the work to which such contribution s was submitted if you
    institute patent litigation against any entity including a cross claim or counterclaim in a lawsuit alleging that the work or a contribution
    incorporated within the work constitutes direct or contributory patent infringement then any patent licenses granted to you under this license for
    that work shall terminate as of the date such litigation is filed
apache-2.0: 4 redistribution you may reproduce and distribute copies of the work or derivative works thereof in any medium with or without
    modifications and in source or object form provided that you meet the following conditions
apache-2.0: a you must give any other recipients of the work or derivative works a copy of this license and
apache-2.0: c you must retain in the source form of any derivative works that you distribute all copyright patent trademark and attribution notices
    from the source form of the work excluding those notices that do not pertain to any part of the derivative works and
apache-2.0: d if the work includes a notice text file as part of its distribution then any derivative works that you distribute must include a
    readable copy of the attribution notices contained within such notice file excluding those notices that do not pertain to any part of the
    derivative works in at least one of the following places within a notice text file distributed as part of the derivative works within the source
    form or documentation if provided along with the derivative works or within a display generated by the derivative works if and wherever such third
    party notices normally appear the contents of the notice file are for informational purposes only and do not modify the license you may add your
    own attribution notices within derivative works that you distribute alongside or as an addendum to the notice text from the work provided that
    such additional attribution notices cannot be construed as modifying the license
apache-2.0: you may add your own copyright statement to your modifications and may provide additional or different license terms and conditions for
    use reproduction or distribution of your modifications or for any such derivative works as a whole provided your use reproduction and distribution
    of the work otherwise complies with the conditions stated in this license
apache-2.0: 5 submission of contributions unless you explicitly state otherwise any contribution intentionally submitted for inclusion in the work by
    you to the licensor shall be under the terms and conditions of this license without any additional terms or conditions notwithstanding the above
    nothing herein shall supersede or modify the terms of any separate license agreement you may have executed with licensor regarding such
    contributions
apache-2.0: 6 trademarks this license does not grant permission to use the trade names trademarks service marks or product names of the licensor
    except as required for reasonable and customary use in describing the origin of the work and reproducing the content of the notice file
apache-2.0: 7 disclaimer of warranty unless required by applicable law or agreed to in writing licensor provides the work and each contributor
    provides its contributions on an as is basis without warranties or conditions of any kind either express or implied including without limitation
    any warranties or conditions of title non infringement merchantability or fitness for a particular purpose you are solely responsible for
    determining the appropriateness of using or redistributing the work and assume any risks associated with your exercise of permissions under this
    license
apache-2.0: 8 limitation of liability in no event and under no legal theory whether in tort including negligence contract or otherwise unless required
    by applicable law such as deliberate and grossly negligent acts or agreed to in writing shall any contributor be liable to you for damages
    including any direct indirect special incidental or consequential damages of any character arising as a result of this license or out of the use
    or inability to use the work including but not limited to damages for loss of goodwill work stoppage computer failure or malfunction or any and
    all other commercial damages or losses even if such contributor has been advised of the possibility of such damages
apache-2.0: 9 accepting warranty or additional liability while redistributing the work or derivative works thereof you may choose to offer and charge
    a fee for acceptance of support warranty indemnity or other liability obligations and or rights consistent with this license however in accepting
    such obligations you may act only on your own behalf and on your sole responsibility not on behalf of any other contributor and only if you agree
    to indemnify defend and hold each contributor harmless for any liability incurred by or claims asserted against such contributor by reason of your
    accepting any such warranty or additional liability
apache-2.0: to apply the apache license to your work attach the following boilerplate notice with the fields enclosed by brackets replaced with your
    own identifying information don t include the brackets the text should be enclosed in the appropriate comment syntax for the file format we also
    recommend that a file or class name and description of purpose be included on the same printed page as the copyright notice for easier
    identification within third party archives
apache-2.0: licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a
    copy of the license at
apache-2.0: unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without
    warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations
    under the license
gpl-2.0: the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is
    intended to guarantee your freedom to share and change free software to make sure the software is free for all its users this general public
    license applies to most of the free software foundation s software and to any other program whose authors commit to using it some other free
    software foundation software is covered by the gnu lesser general public license instead you can apply it to your programs too
gpl: when we speak of free software we are referring to freedom not price our general public licenses are designed to make sure that you have the
    freedom to distribute copies of free software and charge for this service if you wish that you receive source code or can get it if you want it
    that you can change the software or use pieces of it in new free programs and that you know you can do these things
gpl: to protect your rights we need to make restrictions that forbid anyone to deny you these rights or to ask you to surrender the rights these
    restrictions translate to certain responsibilities for you if you distribute copies of the software or if you modify it
gpl: for example if you distribute copies of such a program whether gratis or for a fee you must give the recipients all the rights that you have you
    must make sure that they too receive or can get the source code and you must show them these terms so they know their rights
gpl: we protect your rights with two steps 1 copyright the software and 2 offer you this license which gives you legal permission to copy distribute
    and or modify the software
gpl: also for each author s protection and ours we want to make certain that everyone understands that there is no warranty for this free software if
    the software is modified by someone else and passed on we want its recipients to know that what they have is not the original so that any problems
    introduced by others will not reflect on the original authors reputations
gpl-2.0: finally any free program is threatened constantly by software patents we wish to avoid the danger that redistributors of a free program will
    individually obtain patent licenses in effect making the program proprietary to prevent this we have made it clear that any patent must be
    licensed for everyone s free use or not licensed at all
gpl: gnu general public license terms and conditions for copying distribution and modification
gpl-2.0: 0 this license applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under
    the terms of this general public license the program below refers to any such program or work and a work based on the program means either the
    program or any derivative work under copyright law that is to say a work containing the program or a portion of it either verbatim or with
    modifications and or translated into another language hereinafter translation is included without limitation in the term modification each
    licensee is addressed as you
gpl-2.0: activities other than copying distribution and modification are not covered by this license they are outside its scope the act of running the
    program is not restricted and the output from the program is covered only if its contents constitute a work based on the program independent of
    having been made by running the program whether that is true depends on what the program does
gpl: 1 you may copy and distribute verbatim copies of the program s source code as you receive it in any medium provided that you conspicuously and
    appropriately publish on each copy an appropriate copyright notice and disclaimer of warranty keep intact all the notices that refer to this
    license and to the absence of any warranty and give any other recipients of the program a copy of this license along with the program
gpl: you may charge a fee for the physical act of transferring a copy and you may at your option offer warranty protection in exchange for a fee
gpl: 2 you may modify your copy or copies of the program or any portion of it thus forming a work based on the program and copy and distribute such
    modifications or work under the terms of section 1 above provided that you also meet all of these conditions
gpl: a you must cause the modified files to carry prominent notices stating that you changed the files and the date of any change
gpl-2.0: b you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program or any part thereof
    to be licensed as a whole at no charge to all third parties under the terms of this license
gpl-2.0: c if the modified program normally reads commands interactively when run you must cause it when started running for such interactive use in
    the most ordinary way to print or display an announcement including an appropriate copyright notice and a notice that there is no warranty or else
    saying that you provide a warranty and that users may redistribute the program under these conditions and telling the user how to view a copy of
    this license exception if the program itself is interactive but does not normally print such an announcement your work based on the program is not
    required to print an announcement
gpl: these requirements apply to the modified work as a whole if identifiable sections of that work are not derived from the program and can be
    reasonably considered independent and separate works in themselves then this license and its terms do not apply to those sections when you
    distribute them as separate works but when you distribute the same sections as part of a whole which is a work based on the program the
    distribution of the whole must be on the terms of this license whose permissions for other licensees extend to the entire whole and thus to each
    and every part regardless of who wrote it
gpl: thus it is not the intent of this section to claim rights or contest your rights to work written entirely by you rather the intent is to exercise
    the right to control the distribution of derivative or collective works based on the program
gpl: in addition mere aggregation of another work not based on the program with the program or with a work based on the program on a volume of a
    storage or distribution medium does not bring the other work under the scope of this license
gpl-2.0: 3 you may copy and distribute the program or a work based on it under section 2 in object code or executable form under the terms of sections
    1 and 2 above provided that you also do one of the following
gpl: a accompany it with the complete corresponding machine readable source code which must be distributed under the terms of sections 1 and 2 above
    on a medium customarily used for software interchange or
gpl-2.0: b accompany it with a written offer valid for at least three years to give any third party for a charge no more than your cost of physically
    performing source distribution a complete machine readable copy of the corresponding source code to be distributed under the terms of sections 1
    and 2 above on a medium customarily used for software interchange or
gpl-2.0: c accompany it with the information you received as to the offer to distribute corresponding source code this alternative is allowed only for
    noncommercial distribution and only if you received the program in object code or executable form with such an offer in accord with subsection b
    above
gpl-2.0: the source code for a work means the preferred form of the work for making modifications to it for an executable work complete source code
    means all the source code for all modules it contains plus any associated interface definition files plus the scripts used to control compilation
    and installation of the executable however as a special exception the source code distributed need not include anything that is normally
    distributed in either source or binary form with the major components compiler kernel and so on of the operating system on which the executable
    runs unless that component itself accompanies the executable
gpl: if distribution of executable or object code is made by offering access to copy from a designated place then offering equivalent access to copy
    the source code from the same place counts as distribution of the source code even though third parties are not compelled to copy the source along
    with the object code
gpl: 5 you are not required to accept this license since you have not signed it however nothing else grants you permission to modify or distribute the
    program or its derivative works these actions are prohibited by law if you do not accept this license therefore by modifying or distributing the
    program or any work based on the program you indicate your acceptance of this license to do so and all its terms and conditions for copying
    distributing or modifying the program or works based on it
gpl: 6 each time you redistribute the program or any work based on the program the recipient automatically receives a license from the original
    licensor to copy distribute or modify the program subject to these terms and conditions you may not impose any further restrictions on the
    recipients exercise of the rights granted herein you are not responsible for enforcing compliance by third parties to this license
gpl: 7 if as a consequence of a court judgment or allegation of patent infringement or for any other reason not limited to patent issues conditions
    are imposed on you whether by court order agreement or otherwise that contradict the conditions of this license they do not excuse you from the
    conditions of this license if you cannot distribute so as to satisfy simultaneously your obligations under this license and any other pertinent
    obligations then as a consequence you may not distribute the program at all for example if a patent license would not permit royalty free
    redistribution of the program by all those who receive copies directly or indirectly through you then the only way you could satisfy both it and
    this license would be to refrain entirely from distribution of the program
gpl: if any portion of this section is held invalid or unenforceable under any particular circumstance the balance of the section is intended to apply
    and the section as a whole is intended to apply in other circumstances
gpl: it is not the purpose of this section to induce you to infringe any patents or other property right claims or to contest validity of any such
    claims this section has the sole purpose of protecting the integrity of the free software distribution system which is implemented by public
    license practices many people have made generous contributions to the wide range of software distributed through that system in reliance on
    consistent application of that system it is up to the author donor to decide if he or she is willing to distribute software through any other
    system and a licensee cannot impose that choice
gpl: this section is intended to make thoroughly clear what is believed to be a consequence of the rest of this license
gpl: 8 if the distribution and or use of the program is restricted in certain countries either by patents or by copyrighted interfaces the original
    copyright holder who places the program under this license may add an explicit geographical distribution limitation excluding those countries so
    that distribution is permitted only in or among countries not thus excluded in such case this license incorporates the limitation as if written in
    the body of this license
gpl: 9 the free software foundation may publish revised and or new versions of the general public license from time to time such new versions will be
    similar in spirit to the present version but may differ in detail to address new problems or concerns
gpl: 10 if you wish to incorporate parts of the program into other free programs whose distribution conditions are different write to the author to
    ask for permission for software which is copyrighted by the free software foundation write to the free software foundation we sometimes make
    exceptions for this our decision will be guided by the two goals of preserving the free status of all derivatives of our free software and of
    promoting the sharing and reuse of software generally
gpl: 11 because the program is licensed free of charge there is no warranty for the program to the extent permitted by applicable law except when
    otherwise stated in writing the copyright holders and or other parties provide the program as is without warranty of any kind either expressed or
    implied including but not limited to the implied warranties of merchantability and fitness for a particular purpose the entire risk as to the
    quality and performance of the program is with you should the program prove defective you assume the cost of all necessary servicing repair or
    correction
gpl: 12 in no event unless required by applicable law or agreed to in writing will any copyright holder or any other party who may modify and or
    redistribute the program as permitted above be liable to you for damages including any general special incidental or consequential damages arising
    out of the use or inability to use the program including but not limited to loss of data or data being rendered inaccurate or losses sustained by
    you or third parties or a failure of the program to operate with any other programs even if such holder or other party has been advised of the
    possibility of such damages
gpl: if you develop a new program and you want it to be of the greatest possible use to the public the best way to achieve this is to make it free
    software which everyone can redistribute and change under these terms
gpl: to do so attach the following notices to the program it is safest to attach them to the start of each source file to most effectively convey the
    exclusion of warranty and each file should have at least the copyright line and a pointer to where the full notice is found
gpl: one line to give the program s name and a brief idea of what it does copyright c year name of author
gpl: this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free
    software foundation either version 2 of the license or at your option any later version
gpl: this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or
    fitness for a particular purpose see the gnu general public license for more details
gpl: you should have received a copy of the gnu general public license along with this program if not write to the free software foundation inc 51
    franklin street fifth floor boston ma 02110 1301 usa
gpl: also add information on how to contact you by electronic and paper mail
gpl: if the program is interactive make it output a short notice like this when it starts in an interactive mode
gpl: gnomovision version 69 copyright c year name of author gnomovision comes with absolutely no warranty for details type show w this is free
    software and you are welcome to redistribute it under certain conditions type show c for details
gpl: the hypothetical commands show w and show c should show the appropriate parts of the general public license of course the commands you use may be
    called something other than show w and show c they could even be mouse clicks or menu items whatever suits your program
gpl: you should also get your employer if you work as a programmer or your school if any to sign a copyright disclaimer for the program if necessary
    here is a sample alter the names
gpl-2.0: yoyodyne inc hereby disclaims all copyright interest in the program gnomovision which makes passes at compilers written by james hacker
gpl: signature of ty coon 1 april 1989 ty coon president of vice
gpl: this general public license does not permit incorporating your program into proprietary programs if your program is a subroutine library you may
    consider it more useful to permit linking proprietary applications with the library if this is what you want to do use the gnu lesser general
    public license instead of this license
gpl-3.0: the gnu general public license is a free copyleft license for software and other kinds of works
gpl-3.0: the licenses for most software and other practical works are designed to take away your freedom to share and change the works by contrast the
    gnu general public license is intended to guarantee your freedom to share and change all versions of a program to make sure it remains free
    software for all its users we the free software foundation use the gnu general public license for most of our software it applies also to any
    other work released this way by its authors you can apply it to your programs too
gpl: when we speak of free software we are referring to freedom not price our general public licenses are designed to make sure that you have the
    freedom to distribute copies of free software and charge for them if you wish that you receive source code or can get it if you want it that you
    can change the software or use pieces of it in new free programs and that you know you can do these things
gpl-3.0: to protect your rights we need to prevent others from denying you these rights or asking you to surrender the rights therefore you have
    certain responsibilities if you distribute copies of the software or if you modify it responsibilities to respect the freedom of others
gpl-3.0: for example if you distribute copies of such a program whether gratis or for a fee you must pass on to the recipients the same freedoms that
    you received you must make sure that they too receive or can get the source code and you must show them these terms so they know their rights
gpl-3.0: developers that use the gnu gpl protect your rights with two steps 1 assert copyright on the software and 2 offer you this license giving you
    legal permission to copy distribute and or modify it
gpl-3.0: for the developers and authors protection the gpl clearly explains that there is no warranty for this free software for both users and
    authors sake the gpl requires that modified versions be marked as changed so that their problems will not be attributed erroneously to authors of
    previous versions
gpl-3.0: some devices are designed to deny users access to install or run modified versions of the software inside them although the manufacturer can
    do so this is fundamentally incompatible with the aim of protecting users freedom to change the software the systematic pattern of such abuse
    occurs in the area of products for individuals to use which is precisely where it is most unacceptable therefore we have designed this version of
    the gpl to prohibit the practice for those products if such problems arise substantially in other domains we stand ready to extend this provision
    to those domains in future versions of the gpl as needed to protect the freedom of users
gpl-3.0: finally every program is threatened constantly by software patents states should not allow patents to restrict development and use of
    software on general purpose computers but in those that do we wish to avoid the special danger that patents applied to a free program could make
    it effectively proprietary to prevent this the gpl assures that patents cannot be used to render the program non free
gpl: this license refers to version 3 of the gnu general public license
gpl-3.0: copyright also means copyright like laws that apply to other kinds of works such as semiconductor masks
gpl-3.0: the program refers to any copyrightable work licensed under this license each licensee is addressed as you licensees and recipients may be
    individuals or organizations
gpl-3.0: to modify a work means to copy from or adapt all or part of the work in a fashion requiring copyright permission other than the making of an
    exact copy the resulting work is called a modified version of the earlier work or a work based on the earlier work
gpl-3.0: a covered work means either the unmodified program or a work based on the program
gpl-3.0: to propagate a work means to do anything with it that without permission would make you directly or secondarily liable for infringement under
    applicable copyright law except executing it on a computer or modifying a private copy propagation includes copying distribution with or without
    modification making available to the public and in some countries other activities as well
gpl-3.0: to convey a work means any kind of propagation that enables other parties to make or receive copies mere interaction with a user through a
    computer network with no transfer of a copy is not conveying
gpl-3.0: an interactive user interface displays appropriate legal notices to the extent that it includes a convenient and prominently visible feature
    that 1 displays an appropriate copyright notice and 2 tells the user that there is no warranty for the work except to the extent that warranties
    are provided that licensees may convey the work under this license and how to view a copy of this license if the interface presents a list of user
    commands or options such as a menu a prominent item in the list meets this criterion
gpl-3.0: the source code for a work means the preferred form of the work for making modifications to it object code means any non source form of a
    work
gpl-3.0: a standard interface means an interface that either is an official standard defined by a recognized standards body or in the case of
    interfaces specified for a particular programming language one that is widely used among developers working in that language
gpl-3.0: the system libraries of an executable work include anything other than the work as a whole that a is included in the normal form of packaging
    a major component but which is not part of that major component and b serves only to enable use of the work with that major component or to
    implement a standard interface for which an implementation is available to the public in source code form a major component in this context means
    a major essential component kernel window system and so on of the specific operating system if any on which the executable work runs or a compiler
    used to produce the work or an object code interpreter used to run it
gpl-3.0: the corresponding source for a work in object code form means all the source code needed to generate install and for an executable work run
    the object code and to modify the work including scripts to control those activities however it does not include the work s system libraries or
    general purpose tools or generally available free programs which are used unmodified in performing those activities but which are not part of the
    work for example corresponding source includes interface definition files associated with source files for the work and the source code for shared
    libraries and dynamically linked subprograms that the work is specifically designed to require such as by intimate data communication or control
    flow between those subprograms and other parts of the work
gpl-3.0: the corresponding source need not include anything that users can regenerate automatically from other parts of the corresponding source
gpl-3.0: the corresponding source for a work in source code form is that same work
gpl-3.0: all rights granted under this license are granted for the term of copyright on the program and are irrevocable provided the stated conditions
    are met this license explicitly affirms your unlimited permission to run the unmodified program the output from running a covered work is covered
    by this license only if the output given its content constitutes a covered work this license acknowledges your rights of fair use or other
    equivalent as provided by copyright law
gpl-3.0: you may make run and propagate covered works that you do not convey without conditions so long as your license otherwise remains in force you
    may convey covered works to others for the sole purpose of having them make modifications exclusively for you or provide you with facilities for
    running those works provided that you comply with the terms of this license in conveying all material for which you do not control copyright those
    thus making or running the covered works for you must do so exclusively on your behalf under your direction and control on terms that prohibit
    them from making any copies of your copyrighted material outside their relationship with you
gpl-3.0: conveying under any other circumstances is permitted solely under the conditions stated below sublicensing is not allowed section 10 makes it
    unnecessary
gpl-3.0: no covered work shall be deemed part of an effective technological measure under any applicable law fulfilling obligations under article 11
    of the wipo copyright treaty adopted on 20 december 1996 or similar laws prohibiting or restricting circumvention of such measures
gpl-3.0: when you convey a covered work you waive any legal power to forbid circumvention of technological measures to the extent such circumvention
    is effected by exercising rights under this license with respect to the covered work and you disclaim any intention to limit operation or
    modification of the work as a means of enforcing against the work s users your or third parties legal rights to forbid circumvention of
    technological measures
gpl-3.0: you may convey verbatim copies of the program s source code as you receive it in any medium provided that you conspicuously and appropriately
    publish on each copy an appropriate copyright notice keep intact all notices stating that this license and any non permissive terms added in
    accord with section 7 apply to the code keep intact all notices of the absence of any warranty and give all recipients a copy of this license
    along with the program
gpl-3.0: you may charge any price or no price for each copy that you convey and you may offer support or warranty protection for a fee
gpl-3.0: you may convey a work based on the program or the modifications to produce it from the program in the form of source code under the terms of
    section 4 provided that you also meet all of these conditions
gpl-3.0: a the work must carry prominent notices stating that you modified it and giving a relevant date
gpl-3.0: b the work must carry prominent notices stating that it is released under this license and any conditions added under section 7 this
    requirement modifies the requirement in section 4 to keep intact all notices
gpl-3.0: c you must license the entire work as a whole under this license to anyone who comes into possession of a copy this license will therefore
    apply along with any applicable section 7 additional terms to the whole of the work and all its parts regardless of how they are packaged this
    license gives no permission to license the work in any other way but it does not invalidate such permission if you have separately received it
gpl-3.0: d if the work has interactive user interfaces each must display appropriate legal notices however if the program has interactive interfaces
    that do not display appropriate legal notices your work need not make them do so
gpl-3.0: a compilation of a covered work with other separate and independent works which are not by their nature extensions of the covered work and
    which are not combined with it such as to form a larger program in or on a volume of a storage or distribution medium is called an aggregate if
    the compilation and its resulting copyright are not used to limit the access or legal rights of the compilation s users beyond what the individual
    works permit inclusion of a covered work in an aggregate does not cause this license to apply to the other parts of the aggregate
gpl-3.0: you may convey a covered work in object code form under the terms of sections 4 and 5 provided that you also convey the machine readable
    corresponding source under the terms of this license in one of these ways
gpl-3.0: a convey the object code in or embodied in a physical product including a physical distribution medium accompanied by the corresponding
    source fixed on a durable physical medium customarily used for software interchange
gpl-3.0: b convey the object code in or embodied in a physical product including a physical distribution medium accompanied by a written offer valid
    for at least three years and valid for as long as you offer spare parts or customer support for that product model to give anyone who possesses
    the object code either 1 a copy of the corresponding source for all the software in the product that is covered by this license on a durable
    physical medium customarily used for software interchange for a price no more than your reasonable cost of physically performing this conveying of
    source or 2 access to copy the corresponding source from a network server at no charge
gpl-3.0: c convey individual copies of the object code with a copy of the written offer to provide the corresponding source this alternative is
    allowed only occasionally and noncommercially and only if you received the object code with such an offer in accord with subsection 6b
gpl-3.0: d convey the object code by offering access from a designated place gratis or for a charge and offer equivalent access to the corresponding
    source in the same way through the same place at no further charge you need not require recipients to copy the corresponding source along with the
    object code if the place to copy the object code is a network server the corresponding source may be on a different server operated by you or a
    third party that supports equivalent copying facilities provided you maintain clear directions next to the object code saying where to find the
    corresponding source regardless of what server hosts the corresponding source you remain obligated to ensure that it is available for as long as
    needed to satisfy these requirements
gpl-3.0: e convey the object code using peer to peer transmission provided you inform other peers where the object code and corresponding source of
    the work are being offered to the general public at no charge under subsection 6d
gpl-3.0: a separable portion of the object code whose source code is excluded from the corresponding source as a system library need not be included
    in conveying the object code work
gpl-3.0: a user product is either 1 a consumer product which means any tangible personal property which is normally used for personal family or
    household purposes or 2 anything designed or sold for incorporation into a dwelling in determining whether a product is a consumer product
    doubtful cases shall be resolved in favor of coverage for a particular product received by a particular user normally used refers to a typical or
    common use of that class of product regardless of the status of the particular user or of the way in which the particular user actually uses or
    expects or is expected to use the product a product is a consumer product regardless of whether the product has substantial commercial industrial
    or non consumer uses unless such uses represent the only significant mode of use of the product
gpl-3.0: installation information for a user product means any methods procedures authorization keys or other information required to install and
    execute modified versions of a covered work in that user product from a modified version of its corresponding source the information must suffice
    to ensure that the continued functioning of the modified object code is in no case prevented or interfered with solely because modification has
    been made
gpl-3.0: if you convey an object code work under this section in or with or specifically for use in a user product and the conveying occurs as part of
    a transaction in which the right of possession and use of the user product is transferred to the recipient in perpetuity or for a fixed term
    regardless of how the transaction is characterized the corresponding source conveyed under this section must be accompanied by the installation
    information but this requirement does not apply if neither you nor any third party retains the ability to install modified object code on the user
    product for example the work has been installed in rom
gpl-3.0: the requirement to provide installation information does not include a requirement to continue to provide support service warranty or updates
    for a work that has been modified or installed by the recipient or for the user product in which it has been modified or installed access to a
    network may be denied when the modification itself materially and adversely affects the operation of the network or violates the rules and
    protocols for communication across the network
gpl-3.0: corresponding source conveyed and installation information provided in accord with this section must be in a format that is publicly
    documented and with an implementation available to the public in source code form and must require no special password or key for unpacking
    reading or copying
gpl-3.0: additional permissions are terms that supplement the terms of this license by making exceptions from one or more of its conditions additional
    permissions that are applicable to the entire program shall be treated as though they were included in this license to the extent that they are
    valid under applicable law if additional permissions apply only to part of the program that part may be used separately under those permissions
    but the entire program remains governed by this license without regard to the additional permissions
gpl-3.0: when you convey a copy of a covered work you may at your option remove any additional permissions from that copy or from any part of it
    additional permissions may be written to require their own removal in certain cases when you modify the work you may place additional permissions
    on material added by you to a covered work for which you have or can give appropriate copyright permission
gpl-3.0: notwithstanding any other provision of this license for material you add to a covered work you may if authorized by the copyright holders of
    that material supplement the terms of this license with terms
gpl-3.0: a disclaiming warranty or limiting liability differently from the terms of sections 15 and 16 of this license or
gpl-3.0: b requiring preservation of specified reasonable legal notices or author attributions in that material or in the appropriate legal notices
    displayed by works containing it or
gpl-3.0: c prohibiting misrepresentation of the origin of that material or requiring that modified versions of such material be marked in reasonable
    ways as different from the original version or
gpl-3.0: d limiting the use for publicity purposes of names of licensors or authors of the material or
gpl-3.0: e declining to grant rights under trademark law for use of some trade names trademarks or service marks or
gpl-3.0: f requiring indemnification of licensors and authors of that material by anyone who conveys the material or modified versions of it with
    contractual assumptions of liability to the recipient for any liability that these contractual assumptions directly impose on those licensors and
    authors
gpl-3.0: all other non permissive additional terms are considered further restrictions within the meaning of section 10 if the program as you received
    it or any part of it contains a notice stating that it is governed by this license along with a term that is a further restriction you may remove
    that term if a license document contains a further restriction but permits relicensing or conveying under this license you may add to a covered
    work material governed by the terms of that license document provided that the further restriction does not survive such relicensing or conveying
gpl-3.0: if you add terms to a covered work in accord with this section you must place in the relevant source files a statement of the additional
    terms that apply to those files or a notice indicating where to find the applicable terms
gpl-3.0: additional terms permissive or non permissive may be stated in the form of a separately written license or stated as exceptions the above
    requirements apply either way
gpl-3.0: you may not propagate or modify a covered work except as expressly provided under this license any attempt otherwise to propagate or modify
    it is void and will automatically terminate your rights under this license including any patent licenses granted under the third paragraph of
    section 11
gpl-3.0: termination of your rights under this section does not terminate the licenses of parties who have received copies or rights from you under
    this license if your rights have been terminated and not permanently reinstated you do not qualify to receive new licenses for the same material
    under section 10
gpl-3.0: you are not required to accept this license in order to receive or run a copy of the program ancillary propagation of a covered work
    occurring solely as a consequence of using peer to peer transmission to receive a copy likewise does not require acceptance however nothing other
    than this license grants you permission to propagate or modify any covered work these actions infringe copyright if you do not accept this license
    therefore by modifying or propagating a covered work you indicate your acceptance of this license to do so
gpl-3.0: each time you convey a covered work the recipient automatically receives a license from the original licensors to run modify and propagate
    that work subject to this license you are not responsible for enforcing compliance by third parties with this license
gpl-3.0: an entity transaction is a transaction transferring control of an organization or substantially all assets of one or subdividing an
    organization or merging organizations if propagation of a covered work results from an entity transaction each party to that transaction who
    receives a copy of the work also receives whatever licenses to the work the party s predecessor in interest had or could give under the previous
    paragraph plus a right to possession of the corresponding source of the work from the predecessor in interest if the predecessor has it or can get
    it with reasonable efforts
gpl-3.0: you may not impose any further restrictions on the exercise of the rights granted or affirmed under this license for example you may not
    impose a license fee royalty or other charge for exercise of rights granted under this license and you may not initiate litigation including a
    cross claim or counterclaim in a lawsuit alleging that any patent claim is infringed by making using selling offering for sale or importing the
    program or any portion of it
gpl-3.0: a contributor is a copyright holder who authorizes use under this license of the program or a work on which the program is based the work
    thus licensed is called the contributor s contributor version
gpl-3.0: a contributor s essential patent claims are all patent claims owned or controlled by the contributor whether already acquired or hereafter
    acquired that would be infringed by some manner permitted by this license of making using or selling its contributor version but do not include
    claims that would be infringed only as a consequence of further modification of the contributor version for purposes of this definition control
    includes the right to grant patent sublicenses in a manner consistent with the requirements of this license
gpl-3.0: each contributor grants you a non exclusive worldwide royalty free patent license under the contributor s essential patent claims to make use
    sell offer for sale import and otherwise run modify and propagate the contents of its contributor version
gpl-3.0: in the following three paragraphs a patent license is any express agreement or commitment however denominated not to enforce a patent such as
    an express permission to practice a patent or covenant not to sue for patent infringement to grant such a patent license to a party means to make
    such an agreement or commitment not to enforce a patent against the party
gpl-3.0: if you convey a covered work knowingly relying on a patent license and the corresponding source of the work is not available for anyone to
    copy free of charge and under the terms of this license through a publicly available network server or other readily accessible means then you
    must either 1 cause the corresponding source to be so available or 2 arrange to deprive yourself of the benefit of the patent license for this
    particular work or 3 arrange in a manner consistent with the requirements of this license to extend the patent license to downstream recipients
    knowingly relying means you have actual knowledge that but for the patent license your conveying the covered work in a country or your recipient s
    use of the covered work in a country would infringe one or more identifiable patents in that country that you have reason to believe are valid
gpl-3.0: if pursuant to or in connection with a single transaction or arrangement you convey or propagate by procuring conveyance of a covered work
    and grant a patent license to some of the parties receiving the covered work authorizing them to use propagate modify or convey a specific copy of
    the covered work then the patent license you grant is automatically extended to all recipients of the covered work and works based on it
gpl-3.0: a patent license is discriminatory if it does not include within the scope of its coverage prohibits the exercise of or is conditioned on the
    non exercise of one or more of the rights that are specifically granted under this license you may not convey a covered work if you are a party to
    an arrangement with a third party that is in the business of distributing software under which you make payment to the third party based on the
    extent of your activity of conveying the work and under which the third party grants to any of the parties who would receive the covered work from
    you a discriminatory patent license a in connection with copies of the covered work conveyed by you or copies made from those copies or b
    primarily for and in connection with specific products or compilations that contain the covered work unless you entered into that arrangement or
    that patent license was granted prior to 28 march 2007
gpl-3.0: nothing in this license shall be construed as excluding or limiting any implied license or other defenses to infringement that may otherwise
    be available to you under applicable patent law
gpl-3.0: if conditions are imposed on you whether by court order agreement or otherwise that contradict the conditions of this license they do not
    excuse you from the conditions of this license if you cannot convey a covered work so as to satisfy simultaneously your obligations under this
    license and any other pertinent obligations then as a consequence you may not convey it at all for example if you agree to terms that obligate you
    to collect a royalty for further conveying from those to whom you convey the program the only way you could satisfy both those terms and this
    license would be to refrain entirely from conveying the program
gpl-3.0: notwithstanding any other provision of this license you have permission to link or combine any covered work with a work licensed under
    version 3 of the gnu affero general public license into a single combined work and to convey the resulting work the terms of this license will
    continue to apply to the part which is the covered work but the special requirements of the gnu affero general public license section 13
    concerning interaction through a network will apply to the combination as such
gpl: each version is given a distinguishing version number if the program specifies that a certain numbered version of the gnu general public license
    or any later version applies to it you have the option of following the terms and conditions either of that numbered version or of any later
    version published by the free software foundation if the program does not specify a version number of the gnu general public license you may
    choose any version ever published by the free software foundation
gpl-3.0: if the program specifies that a proxy can decide which future versions of the gnu general public license can be used that proxy s public
    statement of acceptance of a version permanently authorizes you to choose that version for the program
gpl-3.0: later license versions may give you additional or different permissions however no additional obligations are imposed on any author or
    copyright holder as a result of your choosing to follow a later version
gpl: there is no warranty for the program to the extent permitted by applicable law except when otherwise stated in writing the copyright holders and
    or other parties provide the program as is without warranty of any kind either expressed or implied including but not limited to the implied
    warranties of merchantability and fitness for a particular purpose the entire risk as to the quality and performance of the program is with you
    should the program prove defective you assume the cost of all necessary servicing repair or correction
gpl: in no event unless required by applicable law or agreed to in writing will any copyright holder or any other party who modifies and or conveys
    the program as permitted above be liable to you for damages including any general special incidental or consequential damages arising out of the
    use or inability to use the program including but not limited to loss of data or data being rendered inaccurate or losses sustained by you or
    third parties or a failure of the program to operate with any other programs even if such holder or other party has been advised of the
    possibility of such damages
gpl-3.0: if the disclaimer of warranty and limitation of liability provided above cannot be given local legal effect according to their terms
    reviewing courts shall apply local law that most closely approximates an absolute waiver of all civil liability in connection with the program
    unless a warranty or assumption of liability accompanies a copy of the program in return for a fee
gpl: if you develop a new program and you want it to be of the greatest possible use to the public the best way to achieve this is to make it free
    software which everyone can redistribute and change under these terms
gpl: to do so attach the following notices to the program it is safest to attach them to the start of each source file to most effectively state the
    exclusion of warranty and each file should have at least the copyright line and a pointer to where the full notice is found
gpl: one line to give the program s name and a brief idea of what it does copyright c year name of author
gpl: this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free
    software foundation either version 3 of the license or at your option any later version
gpl: this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or
    fitness for a particular purpose see the gnu general public license for more details
gpl-3.0: you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses
gpl: also add information on how to contact you by electronic and paper mail
gpl: if the program does terminal interaction make it output a short notice like this when it starts in an interactive mode
gpl: program copyright c year name of author this program comes with absolutely no warranty for details type show w this is free software and you are
    welcome to redistribute it under certain conditions type show c for details
gpl-3.0: the hypothetical commands show w and show c should show the appropriate parts of the general public license of course your program s commands
    might be different for a gui interface you would use an about box
gpl-3.0: you should also get your employer if you work as a programmer or school if any to sign a copyright disclaimer for the program if necessary
    for more information on this and how to apply and follow the gnu gpl see https www gnu org licenses
gpl-3.0: the gnu general public license does not permit incorporating your program into proprietary programs if your program is a subroutine library
    you may consider it more useful to permit linking proprietary applications with the library if this is what you want to do use the gnu lesser
    general public license instead of this license but first please read https www gnu org licenses why not lgpl html
mpl-2.0: 1 1 contributor means each individual or legal entity that creates contributes to the creation of or owns covered software
mpl-2.0: 1 2 contributor version means the combination of the contributions of others if any used by a contributor and that particular contributor s
    contribution
mpl-2.0: 1 4 covered software means source code form to which the initial contributor has attached the notice in exhibit a the executable form of such
    source code form and modifications of such source code form in each case including portions thereof
mpl-2.0: a that the initial contributor has attached the notice described in exhibit b to the covered software or
mpl-2.0: b that the covered software was made available under the terms of version 1 1 or earlier of the license but not also under the terms of a
    secondary license
mpl-2.0: 1 6 executable form means any form of the work other than source code form
mpl-2.0: 1 7 larger work means a work that combines covered software with other material in a separate file or files that is not covered software
mpl-2.0: a any file in source code form that results from an addition to deletion from or modification of the contents of covered software or
mpl-2.0: b any new file in source code form that contains any covered software
mpl-2.0: 1 11 patent claims of a contributor means any patent claim s including without limitation method process and apparatus claims in any patent
    licensable by such contributor that would be infringed but for the grant of the license by the making using selling offering for sale having made
    import or transfer of either its contributions or its contributor version
mpl-2.0: 1 12 secondary license means either the gnu general public license version 2 0 the gnu lesser general public license version 2 1 the gnu
    affero general public license version 3 0 or any later versions of those licenses
mpl-2.0: 1 13 source code form means the form of the work preferred for making modifications
mpl-2.0: a under intellectual property rights other than patent or trademark licensable by such contributor to use reproduce make available modify
    display perform distribute and otherwise exploit its contributions either on an unmodified basis with modifications or as part of a larger work
    and
mpl-2.0: b under patent claims of such contributor to make use sell offer for sale have made import and otherwise transfer either its contributions or
    its contributor version
mpl-2.0: the licenses granted in section 2 1 with respect to any contribution become effective for each contribution on the date the contributor first
    distributes such contribution
mpl-2.0: the licenses granted in this section 2 are the only rights granted under this license no additional rights or licenses will be implied from
    the distribution or licensing of covered software under this license notwithstanding section 2 1 b above no patent license is granted by a
    contributor
mpl-2.0: a for any code that a contributor has removed from covered software or
mpl-2.0: b for infringements caused by i your and any other third party s modifications of covered software or ii the combination of its contributions
    with other software except as part of its contributor version or
mpl-2.0: c under patent claims infringed by covered software in the absence of its contributions
mpl-2.0: this license does not grant any rights in the trademarks service marks or logos of any contributor except as may be necessary to comply with
    the notice requirements in section 3 4
mpl-2.0: no contributor makes additional grants as a result of your choice to distribute the covered software under a subsequent version of this
    license see section 10 2 or under the terms of a secondary license if permitted under the terms of section 3 3
mpl-2.0: each contributor represents that the contributor believes its contributions are its original creation s or it has sufficient rights to grant
    the rights to its contributions conveyed by this license
mpl-2.0: this license is not intended to limit any rights you have under applicable copyright doctrines of fair use fair dealing or other equivalents
mpl-2.0: sections 3 1 3 2 3 3 and 3 4 are conditions of the licenses granted in section 2 1
mpl-2.0: all distribution of covered software in source code form including any modifications that you create or to which you contribute must be under
    the terms of this license you must inform recipients that the source code form of the covered software is governed by the terms of this license
    and how they can obtain a copy of this license you may not attempt to alter or restrict the recipients rights in the source code form
mpl-2.0: a such covered software must also be made available in source code form as described in section 3 1 and you must inform recipients of the
    executable form how they can obtain a copy of such source code form by reasonable means in a timely manner at a charge no more than the cost of
    distribution to the recipient and
mpl-2.0: b you may distribute such executable form under the terms of this license or sublicense it under different terms provided that the license
    for the executable form does not attempt to limit or alter the recipients rights in the source code form under this license
mpl-2.0: you may create and distribute a larger work under terms of your choice provided that you also comply with the requirements of this license
    for the covered software if the larger work is a combination of covered software with a work governed by one or more secondary licenses and the
    covered software is not incompatible with secondary licenses this license permits you to additionally distribute such covered software under the
    terms of such secondary license s so that the recipient of the larger work may at their option further distribute the covered software under the
    terms of either this license or such secondary license s
mpl-2.0: you may not remove or alter the substance of any license notices including copyright notices patent notices disclaimers of warranty or
    limitations of liability contained within the source code form of the covered software except that you may alter any license notices to the extent
    required to remedy known factual inaccuracies
mpl-2.0: you may choose to offer and to charge a fee for warranty support indemnity or liability obligations to one or more recipients of covered
    software however you may do so only on your own behalf and not on behalf of any contributor you must make it absolutely clear that any such
    warranty support indemnity or liability obligation is offered by you alone and you hereby agree to indemnify every contributor for any liability
    incurred by such contributor as a result of warranty support indemnity or liability terms you offer you may include additional disclaimers of
    warranty and limitations of liability specific to any jurisdiction
mpl-2.0: 5 1 the rights granted under this license will terminate automatically if you fail to comply with any of its terms however if you become
    compliant then the rights granted under this license from a particular contributor are reinstated a provisionally unless and until such
    contributor explicitly and finally terminates your grants and b on an ongoing basis if such contributor fails to notify you of the non compliance
    by some reasonable means prior to 60 days after you have come back into compliance moreover your grants from a particular contributor are
    reinstated on an ongoing basis if such contributor notifies you of the non compliance by some reasonable means this is the first time you have
    received notice of non compliance with this license from such contributor and you become compliant prior to 30 days after your receipt of the
    notice
mpl-2.0: 5 2 if you initiate litigation against any entity by asserting a patent infringement claim excluding declaratory judgment actions counter
    claims and cross claims alleging that a contributor version directly or indirectly infringes any patent then the rights granted to you by any and
    all contributors for the covered software under section 2 1 of this license shall terminate
mpl-2.0: 5 3 in the event of termination under sections 5 1 or 5 2 above all end user license agreements excluding distributors and resellers which
    have been validly granted by you or your distributors under this license prior to termination shall survive termination
mpl-2.0: any litigation relating to this license may be brought only in the courts of a jurisdiction where the defendant maintains its principal place
    of business and such litigation shall be governed by laws of that jurisdiction without reference to its conflict of law provisions nothing in this
    section shall prevent a party s ability to bring cross claims or counter claims
mpl-2.0: this license represents the complete agreement concerning the subject matter hereof if any provision of this license is held to be
    unenforceable such provision shall be reformed only to the extent necessary to make it enforceable any law or regulation which provides that the
    language of a contract shall be construed against the drafter shall not be used to construe this license against a contributor
mpl-2.0: mozilla foundation is the license steward except as provided in section 10 3 no one other than the license steward has the right to modify or
    publish new versions of this license each version will be given a distinguishing version number
mpl-2.0: you may distribute the covered software under the terms of the version of the license under which you originally received the covered
    software or under the terms of any subsequent version published by the license steward
mpl-2.0: if you create software not governed by this license and you want to create a new license for such software you may create and use a modified
    version of this license if you rename the license and remove any references to the name of the license steward except to note that such modified
    license differs from this license
mpl-2.0: 10 4 distributing source code form that is incompatible with secondary licenses
mpl-2.0: if you choose to distribute source code form that is incompatible with secondary licenses under the terms of this version of the license the
    notice described in exhibit b of this license must be attached
mpl-2.0: this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you
    can obtain one at http mozilla org mpl 2 0
mpl-2.0: if it is not possible or desirable to put the notice in a particular file then you may include the notice in a location such as a license
    file in a relevant directory where a recipient would be likely to look for such a notice
mpl-2.0: this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0
mit-text: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
    to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or
    sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
mit-text: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-text: the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
    merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim
    damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or
    other dealings in the software
isc: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
    copyright notice and this permission notice appear in all copies
isc: the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of
    merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages
    whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in
    connection with the use or performance of this software
unlicense: anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for
    any purpose commercial or non commercial and by any means
bsd: redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd: 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd: 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
    documentation and or other materials provided with the distribution
bsd: 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
    software without specific prior written permission
bsd: this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the
    implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors
    be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute
    goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict
    liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such
    damage
""".strip()


def paragraphs(text: str = PARAGRAPHS) -> list[tuple[str, str]]:
    """(words, label) of every paragraph; indented lines go on with the one before."""
    rows: list[list[str]] = []
    for line in text.splitlines():
        if line.startswith(" "):
            rows[-1].append(line.strip())
        else:
            rows.append([line])
    named = [" ".join(row).partition(": ") for row in rows]
    return [(words, label) for label, _, words in named]
